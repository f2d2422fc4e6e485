"""Short sentences, abbreviations and word borders in the search for leaked sentences."""

import random

import pytest

from lexiloom.llm import leaks
from lexiloom.llm.skeleton import borders, skeleton


def found(passages, texts):
    return set(leaks.Searcher(list(enumerate(passages))).items(list(range(len(texts))), texts))


@pytest.mark.parametrize(("sentence", "text"), [
    ("It was sold twice.", "It was was sold twice."), ("She left Oslo in May.", "Then: she left left Oslo in May!"), ("It was sold twice.", "It was slod twice, they say."), ("It was sold twice.", "It sold twice."),
    ("寺は町の北にある。", "昔、寺はは町の北にある。"), ("I am he.", "I am am he."), ("Yes.", "Yes. And then it rained."), ("He sold it all.", "He sold it all"),
])
def test_short_sentences_slip(sentence, text):
    assert found([sentence], [text]) == {(0, 0)}


@pytest.mark.parametrize(("passage", "text"), [
    ("Dr. Hale came home late.", "Drones and dr. Smith"), ("Yes. It rained all day long.", "Yesterday it rained."), ("He met Dr. Hale there today.", "He met Dr. Smith."), ("J. R. Marlow built the old mill.", "J. and R. went home"),
    ("The art of war is old.", "The art of warfare is old."), ("Ann ran.", "Joann ran."), ("Ran by.", "He outran by"), ("A fox ran by.", ""),
])
def test_fragments_and_parts_of_words_do_not_match(passage, text):
    assert found([passage], [text]) == set()


def test_sentences():
    assert leaks.sentences("Dr. Hale came. He met J. R. Marlow there. It cost 5 pounds. Nobody knew why. The end.") == ["Dr. Hale came.", "He met J. R. Marlow there.", "It cost 5 pounds.", "Nobody knew why. The end."]
    assert leaks.sentences("寺がある。町だ。") == ["寺がある。", "町だ。"] and leaks.sentences(None) == leaks.sentences(" ") == [] and leaks.sentences("Yes.") == ["Yes."]


def test_borders():
    assert borders("<b>Old</b> mill, ½!") == [0, 3, 7, 8, 9, 9] and skeleton("<b>Old</b> mill, ½!") == "oldmill12"
    long = "theoldmilloftarinwassoldforagreatdealofmoney"  # glued words have no borders
    assert found(["Was sold for a great deal."], [long]) == {(0, 0)}


def test_every_single_slip_is_found():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(4, 9))) + "." for _ in range(80)]
    texts, want = [], set()
    for n, p in enumerate(passages):
        for _ in range(6):
            w = p[:-1].split()
            i, kind = rng.randrange(len(w)), rng.choice(["drop", "double", "letter", "swap", "none"])
            if kind == "drop":
                w[i : i + 1] = []
            elif kind == "double":
                w[i:i] = [w[i]]
            elif kind == "letter":
                j = rng.randrange(len(w[i]))
                w[i] = w[i][:j] + rng.choice("xyz") + w[i][j + rng.randint(0, 1) :]
            elif kind == "swap" and len(w[i]) > 1:
                j = rng.randrange(len(w[i]) - 1)
                w[i] = w[i][:j] + w[i][j + 1] + w[i][j] + w[i][j + 2 :]
            want.add((len(texts), n))
            texts.append(f"{word()}, {word()}. {' '.join(w)}. {word()}")
    got = found(passages, texts)
    assert len(want & got) / len(want) >= 0.99 and want <= got
