"""Words by Unicode, and the whole vocabulary in the sums."""

import collections
import re
import time
import tracemalloc
import unicodedata

import numpy as np
import pandas as pd
import pytest

from riskweave.llm import common, language, packing, toxicity


def test_words_are_letters_with_their_marks():
    assert language.words_of("²½ Ⅷ ① 12 _ ́") == []
    assert language.words_of("हिन्दी, Éa_b 3c") == ["हिन्दी", "éa", "b", "c"]
    assert language.words_of(None) == []


def test_words_beyond_the_basic_plane():
    assert language.words_of("😀x😀 é𑄀𑄁a 𑄀 漢字𠀀 𝒳𝒴, 𐐀b") == ["x", "é𑄀𑄁a", "漢字𠀀", "𝒳𝒴", "𐐨b"]
    near = [chr(k) for k in (*range(0x2000), *range(0xF900, 0x12000))]
    for between in ("", " ", "a", "\u0301", "𑄀", "😀"):
        text = between.join(near).lower()
        want, word = [], ""
        for c in text + " ":
            kind = unicodedata.category(c)[0]
            if kind == "L" or (kind == "M" and word):
                word += c
            elif word:
                want.append(word)
                word = ""
        assert language.words_of(text) == want


def test_signs_are_not_compared_with_letters_beyond_the_basic_plane():
    text, plain = "ab, 1; - (2) " * 20_000, re.compile("[a-z][a-z]*")

    def least_time(find):
        times = []
        for _ in range(5):
            begin = time.process_time()
            assert len(find(text)) == 20_000
            times.append(time.process_time() - begin)
        return min(times)

    assert least_time(language.words_of) < 6 * least_time(plain.findall)


def test_texts_without_letters_are_unknown():
    counts = pd.DataFrame({"y": ["es", "en"], "piece": ["▁a", "▁b"], "n": [3, 3]})
    model = language._model(counts, language.vocabulary())
    answers = language._answers(["²½ Ⅷ ①", "", None, "a"], model)
    assert answers[0] == ["und", "und", "und", "es"]
    assert answers[1][:3] == [0.0, 0.0, 0.0]


def test_all_pieces_of_the_vocabulary_take_part():
    pieces = language.vocabulary()
    assert len(pieces) > 30_000
    counts = pd.DataFrame({"y": ["es", "en"], "piece": ["▁a", "zz"], "n": [3, 3]})
    model = language._model(counts, pieces)
    assert set(pieces) <= set(model.numbers)
    assert model.probabilities.sum(axis=0) == pytest.approx([1.0, 1.0])
    assert language._model(counts.iloc[:0], pieces).languages == ()


def _model():
    counts = pd.DataFrame({"y": ["es", "en"], "piece": ["▁a", "bb"], "n": [3, 3]})
    return language._model(counts, language.vocabulary())


def test_a_long_word_takes_no_more_memory_than_a_short_one():
    model = _model()
    short = [f"a{'b' * (k % 9)}" for k in range(300)]
    words = [*short, "bca" * 2000]
    tracemalloc.start()
    scores = language.word_scores(model, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000  # all steps of all words would be 29 MB
    assert np.array_equal(scores[:-1], language.word_scores(model, short))
    # The long one by the plain sum over its last piece, step by step in logarithms.
    marked, unknown = "▁" + words[-1], len(model.numbers)
    sums = [np.zeros(len(model.languages))]
    for end in range(1, len(marked) + 1):
        last = [(end - size, marked[end - size : end]) for size in range(1, min(end, language.LONGEST) + 1)]
        terms = [
            sums[at] + np.log(model.probabilities[model.numbers.get(piece, unknown)])
            for at, piece in last
            if piece in model.numbers or at == end - 1
        ]
        sums.append(np.logaddexp.reduce(terms, axis=0))
    assert scores[-1] == pytest.approx(sums[-1])


def test_pieces_are_counted_without_a_list_of_all_words():
    processor = language._processor(language.PIECES)
    texts = ["one word, another word " * 40_000, "word", "", "12"]
    tracemalloc.start()
    got = language._piece_counts(texts, processor)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    words = collections.Counter(w for text in texts for w in language.words_of(text))
    want = collections.Counter()
    for word, n in words.items():
        for piece in processor.encode(word, out_type=str):
            want[piece] += n
    assert got == want and want.total() >= 160_001
    assert language._piece_counts(["", "12"], processor) == {}
    assert peak < 20_000_000


def test_a_worker_remembers_for_one_stage_only():
    model = _model()
    language._answers(["a ab abb"], model)
    assert len(common.remembered(model, dict).rows) == 3
    scorer = toxicity.Model(np.ones(1 << toxicity.BITS, np.float32), 0.0)
    toxicity._scores(["a ab"], scorer)
    assert set(common.remembered(scorer, list)) == {"a", "ab"}
    encode = packing._encoder()
    assert common._memory[1] is encode is packing._encoder()
    language._answers(["a"], model)
    assert len(common.remembered(model, dict).rows) == 1
    common.forget()
    assert common._memory == []
