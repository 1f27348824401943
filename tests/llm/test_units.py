"""The operators' inner functions against brute force, round trips and cases."""

import random
import unicodedata

import numpy as np
import pytest

tokens = pytest.importorskip("loomtext.llm.tokens")
from loomtext.llm import lookalikes, overlap, packing, quality, repair, sentences  # noqa: E402


@pytest.mark.parametrize(
    "text, want",
    [
        ("Bu gün gəldi. Sabah gedir.", ["Bu gün gəldi.", "Sabah gedir."]),
        ("Akad. Pənba b.e.ə. 394-ci ildə 3.14 kv. km aldı. Son.", ["Akad. Pənba b.e.ə. 394-ci ildə 3.14 kv. km aldı.", "Son."]),
        ("Alma, armud və s. Bu isə son.", ["Alma, armud və s.", "Bu isə son."]),
        ("«Bir gəldi. İki getdi», – deyə yazdı. Son.", ["«Bir gəldi. İki getdi», – deyə yazdı.", "Son."]),
        ("O dedi: \"Gəl! Get.\" Sonra getdi.", ["O dedi: \"Gəl! Get.\"", "Sonra getdi."]),
        ("Bitdi.Başladı", ["Bitdi.", "Başladı"]),
        ("Başlıq\n- bənd bir\n1. Ad Soyad", ["Başlıq", "- bənd bir", "1. Ad Soyad"]),
        ("为什么？他说：“好。不好。”完……了。", ["为什么？", "他说：“好。不好。”", "完……了。"]),
        ("「はい。いいえ」と書いた。終わり！", ["「はい。いいえ」と書いた。", "終わり！"]),
        ("หมู่บ้านเก่า โรงสีใหม่ในปี 1791 โดย", ["หมู่บ้านเก่า", "โรงสีใหม่ในปี 1791 โดย"]),
        ("Здесь были сад и т. д. По данным акад. Иванов. И. Петров пришёл.", ["Здесь были сад и т. д.", "По данным акад. Иванов.", "И. Петров пришёл."]),
        ("Am 3. Mai 1411 z. B. die Wiese. Ende", ["Am 3. Mai 1411 z. B. die Wiese.", "Ende"]),
        ("It closed at 7 p.m. The end. See fig. 5 by Dr. X.", ["It closed at 7 p.m.", "The end.", "See fig. 5 by Dr. X."]),
        ("डॉ. कवि आया। नया है?", ["डॉ. कवि आया।", "नया है?"]),
        ("a​кад. Бим.  Да", ["a​кад. Бим.", "Да"]),
        ("", []), (None, []), (" \n　", []),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentences(text)] == want


def test_sentences_cover_the_text():
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choices("aB. !?\n\"“”«»()1。…​ก ", k=random.randint(0, 60)))
        spans = sentences.sentences(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        held = {i for a, b in spans for i in range(a, b)}
        assert all(c.isspace() or c == "​" or i in held for i, c in enumerate(text))


def test_byte_bpe_equals_a_library():
    tiktoken = pytest.importorskip("tiktoken")
    bpe = tokens.encoder(tokens.vocabulary_path())
    library = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=bpe.ranks, special_tokens={})
    random.seed(4)
    cases = ["", "<|endoftext|>", "x's 've'rex 'LL", "a" * 3000, "  \n\t x　y ", "é ə 😀 字 ½ ٣", "".join(map(chr, range(1, 400)))]
    cases += ["".join(random.choices("abcə 'ş\n.1é😀s", k=50)) for _ in range(200)]
    for text in cases:
        ids = list(np.frombuffer(bpe.encode(text), np.int32))
        assert ids == library.encode_ordinary(text), text
        assert b"".join(tokens.token_bytes(tokens.vocabulary_path())[i] for i in ids).decode() == text


def test_best_fit_places_every_rank_once():
    random.seed(5)
    for _ in range(60):
        capacity = random.randint(5, 60)
        histogram = {n: random.randint(1, 40) for n in random.sample(range(1, capacity + 1), random.randint(1, capacity))}
        held, used = {}, {}
        for length, first, per, containers, start in packing.best_fit(histogram, capacity):
            for c in range(containers):
                for k in range(per):
                    held.setdefault(length, []).append(first + c * per + k)
                    used[start + c] = used.get(start + c, 0) + length
        assert {k: sorted(v) for k, v in held.items()} == {k: list(range(v)) for k, v in histogram.items()}
        assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
        room = []  # best fit, item by item
        for n in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
            fits = [i for i, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= n
            else:
                room.append(capacity - n)
        assert len(used) <= 1.05 * len(room) + 1


def test_forms():
    f = lambda x: lookalikes.forms([x])[0]
    assert f("  Ａbс​  d ") == "Abc d" and f("é") == "é" and f("ӘƏәǝə") == "ƏƏəəə"
    assert f("ạ̇") == f("ạ̇") and f("한국") == "한국"
    assert len({f(x) for x in ("ab", "Ab", "áb", "ab.", "ab²", "ıb", "ib")}) == 7
    random.seed(6)
    texts = ["".join(random.choices("aаｂ é́​ 가한ﬁ\n\x00Ёİ", k=12)) for _ in range(200)]
    once = lookalikes.forms(texts)
    assert once == [f(t) for t in texts] == lookalikes.forms(once)
    assert all(unicodedata.is_normalized("NFC", t) for t in once) and lookalikes.forms([]) == []


COMMON = {"the": ("en",), "i": ("en",), "it": ("en",), "for": ("en",), "and": ("en",), "we": ("en",), "və": ("az",), "bu": ("az", "tr"), "der": ("de",), "und": ("de",)}


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("I said no. She left.", 2), ("I like it. She left home.", 2), ("See No. 5 for it. Ok.", 2), ("We saw the str. Then we left.", 2), ("And Mr. Smith left. I saw it.", 2),
        ("Der Weg und der Hof in der Str. 5 war lang. Er ging.", 2), ("Bu və akad. Əliyev gəldi. O getdi.", 2), ("По данным акад. Иванов ушёл. Он там.", 2),
    ],
)
def test_abbreviations_hold_in_their_language(text, n):
    assert len(sentences.sentences(text, COMMON)) == n


@pytest.mark.parametrize("part", ["Mr. Smith ", "A.", "a.b.C", "((( ", "“ ”» ", "1. ", "… ", ". ", "« ) "])
def test_time_grows_with_the_line(part):
    import time

    began = time.process_time()
    sentences.sentences(part * (80_000 // len(part)))
    assert time.process_time() - began < 3


def test_words_are_compared_plainly():
    form = lambda w: overlap.plain(lookalikes.forms([w])[0])
    assert {form(w) for w in ("Çoх", "çooox!", "«ÇOX»", "çox", "çox👍")} == {"cox"}
    assert form("👍👍") == "" and form("-") == "" and form("Iı") == "i" and form("əE") == "e"


def test_overlapping_records_share_a_fingerprint():
    random.seed(7)
    met = 0
    for k in range(4000):
        n = random.randint(8, 120) if k % 2 else random.randint(48, 70)
        a = random.sample(range(1, 400), n)
        b = list(a)
        for _ in range(random.randint(0, n // 5)):
            b[random.randrange(len(b))] = random.randint(400, 900)
        b += random.sample(range(900, 999), random.randint(0, n // 4))
        if random.random() < 0.3:
            b = b[: random.randint(int(0.8 * n), len(b))]
        b = list(set(b))
        if len(b) < 8 or len(set(a) & set(b)) < 0.8 * max(n, len(b)):
            continue
        met += 1
        hot = random.random()
        counts = {w: random.choice((25, 30, 999)) if random.random() < hot else 0 for w in set(a) | set(b)}
        words = [np.array(sorted(x, key=lambda w: (counts[w], w)), np.int32) for x in (a, b)]
        sizes = np.array([len(a), len(b)])
        rows, place, seeds = overlap.seeds_of(np.concatenate(words), sizes, np.array([sum(not counts[w] for w in x) for x in (a, b)]))
        found = [dict(zip(seeds[rows == i].tolist(), place[rows == i].tolist(), strict=True)) for i in (0, 1)]
        both = found[0].keys() & found[1].keys()
        assert both
        assert all(words[0][found[0][x]] == words[1][found[1][x]] for x in both)
        assert sizes.min() <= 64 or len(rows) <= 3 * sizes.sum()
    assert met > 500


def test_repeated_words_are_numbered():
    rows, words = overlap.numbered(np.array([0, 0, 0, 1]), np.array([7, 7, 9, 7], np.uint32))
    assert list(rows) == [0, 0, 0, 1] and len(set(words[:3].tolist())) == 3 and words[3] == 7


def clean_model():
    texts = ["Məktəbdə böyük şəhər haqqında yeni kitab oxundu, çünki dəniz göründü.", "Новый архив был найден в старом городе, там открыли музей."] * 50
    joined = "\n".join(texts)
    c = repair.classes(joined)
    pairs, n = np.unique(c[:-1] * repair.CODES + c[1:], return_counts=True)
    one, m = np.unique(np.minimum(np.array([ord(x) for x in joined]), repair.SINGLE - 1), return_counts=True)
    return repair.Model(np.concatenate([pairs, -1 - one]), np.concatenate([n, m]))


@pytest.mark.parametrize("seen, written", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "utf-8"), ("cp1252", "cp1251")])
def test_wrong_decoding_is_found_and_undone(seen, written):
    model, chain = clean_model(), repair.CHAINS.index((seen, written))
    text = "Новый архив был найден" if written == "cp1251" else "Məktəbdə böyük şəhər göründü"
    table = {b: chr(c) for c, b in repair.bytes_of(seen).items()}
    spoilt = "".join(table[b] for b in text.encode(written))
    gains = repair.evidence(spoilt, model)
    assert gains[chain] > 20 and repair.apply(chain, spoilt, model) == text
    assert repair.evidence(text, model).max() == 0


def test_lost_characters():
    model = clean_model()
    assert repair.evidence("M?kt?bd? böyük", model)[repair.LOST] > 5
    assert repair.evidence("m�kt�b", model)[repair.LOST] > 50
    assert repair.evidence("Necə? Bax site.example/?q=1 Hə?", model).max() == 0


def test_quality_statistics_are_defined():
    for text in ("", " ", "\n\n", ".", "a", "| a | b |\n| 1 | 2 |", "字" * 500, "​"):
        lang, stats = quality.statistics(text, {"az": frozenset({"və"})})
        assert len(stats) == quality.SIZE + len(quality.REPORTED) and np.isfinite(stats).all()
