"""Toxicity: support of marks by whole texts, and spaced words in a row."""

import collections
import random
import re
import time
import zlib

from lectern.llm import toxicity


def test_texts_of_one_opening(spark):
    """A header of 60 characters and more on every text hides neither marks nor clean uses; near copies count once."""
    r = random.Random(6)
    plain = [f"{a}{b}" for a in ("river", "stone", "house", "winter", "garden") for b in ("", "side", "land", "ward")]
    header = "this passage opens every single text of the source and is quite long indeed. "
    rows, labels = [], []
    for k in range(400):
        words = r.choices(plain, k=40)
        if k % 4 == 0:
            # in separate halves, so that neither takes the other's place
            words[r.randrange(20)] = "skrunk"
            words[20 + r.randrange(20)] = "fairish"
        elif k % 4 == 1:
            words[r.randrange(40)] = "fairish"
        rows.append((k, header + " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    copied = r.choices(plain, k=60)
    for k in range(400, 480):
        rows.append((k, " ".join([*copied, "copyword", f"end{k}"])))
        labels.append((k, 1))
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    weights = toxicity.train(docs, known).weights
    assert "=skrunk" in weights and "=fairish" not in weights and "=copyword" not in weights


def test_spaced_words_in_a_row():
    """A blank or sign may be the border of two words, also in a run of more than 64 characters."""
    words = "idiot stupid moron loser and the of a with for people clown you are such so".split()
    grams = collections.Counter(p[k : k + 3] for w in words for p in [f"^^{w}$"] for k in range(len(p) - 2))
    model = toxicity.CharacterModel({g: 50.0 * n for g, n in grams.items()})
    spaced = lambda *x: " ".join("".join(x))
    for written in (spaced("you", "stupid"), spaced("a", "stupid"), spaced("you", "are", "stupid"), "you.1d10t", spaced("so", "$tup!d")):
        assert {"stupid", "idiot"} & toxicity.restored_words(written, model, {}), written
    for at in range(10, 50):
        long = spaced(*["the", "people"][: at % 3], *["and"] * at, "moron", *["for"] * 9)
        assert "moron" in toxicity.restored_words(long, model, {}), long


def test_learns_from_all_labelled_texts(spark, monkeypatch):
    """No labelled text is left out, features that a task passes on early are summed, and copies of one text count once."""
    monkeypatch.setattr(toxicity, "HELD", 50)
    r = random.Random(3)
    plain = [f"{a}{b}" for a in ("river", "stone", "house", "winter", "garden") for b in ("", "side", "land", "ward")]
    rows = [(k, " ".join([*r.choices(plain, k=30), *(["skrunk"] if k % 8 == 0 else [])]), int(k % 8 == 0)) for k in range(21000)]
    rows += [(30000 + k, rows[3][1], 0) for k in range(50)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")
    known = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id bigint, toxic int")
    kept = {x[0] for x in rows if zlib.crc32(str(x[0]).encode()) % 5 != 0}
    texts = toxicity.training_texts(docs, known, "doc_id", "text")
    assert texts.count() == len(kept) and abs(sum(x["weight"] for x in texts.where(texts.text == rows[3][1]).collect()) - 1) < 1e-9
    assert "=skrunk" in toxicity.train(docs, known).weights


def test_places_are_found_in_one_reading():
    """The places are those of the plain expressions, tried at each character, and a long word is not read from each of its letters."""
    signs = re.escape("".join(toxicity.MEANT))
    plain = re.compile(
        rf"(?<![^\W\d_])[^\W\d_](?:[{re.escape(toxicity.BETWEEN)}][\w{signs}](?![^\W\d_])){{3,}}"
        rf"|[{signs}]*[^\W\d_]+[{signs}*._\-~][\w{signs}*._\-~]*[\w{signs}]"
        rf"|[{signs}]+[^\W\d_][\w{signs}*._\-~]*"
        r"|\w*([^\W\d_])\1\1\w*"
    )
    plain_odd = re.compile(rf"[{signs}*_~\-]|\w\.\w|([^\W\d_])\1\1|(?<!\w)\w[ .]\w[ .]\w[ .]\w(?!\w)")
    r = random.Random(4)
    for _ in range(20000):
        text = "".join(r.choices(r.choice(("abcaab aé", "ab1_.-*~ !@$0é", "aa..  __11!!", "a b.c-d_1", "ab \n\t,.;ñß9_²٣𝒜")), k=r.choice((3, 8, 20, 60)))).lower()
        found = (toxicity.DISGUISED if toxicity.trebled(text) else toxicity.DISGUISED_ONLY).finditer(text)
        assert [m.span() for m in found if m["place"]] == [m.span() for m in plain.finditer(text)], text
        assert toxicity.odd(text) == bool(plain_odd.search(text)), text
    wanted = {"=stone", "ston", "stones", "river side"}
    for text in ("stones by the river side", "stone river river side sto", "Stoned riverside", ""):
        assert toxicity.finder(wanted)(text) == toxicity.features(toxicity.WORD.findall(text.lower())) & wanted
    began = time.process_time()
    model = toxicity.CharacterModel({"^^i": 1.0, "^id": 1.0})
    assert "ab" * 30000 in toxicity.restored_words("ab" * 30000 + " 1d10t", model, {})
    assert time.process_time() - began < 2


def test_a_stretch_is_read_once(monkeypatch):
    """A disguised stretch is read once, plain words are not read, and a full memory changes nothing of what is found."""
    text = "stones by the river side, $tones by the r.i.v.e.r "
    plain, parts = toxicity.read, []
    monkeypatch.setattr(toxicity, "read", lambda *x: parts.append(x[0]) or plain(*x))
    model, kept = toxicity.CharacterModel({"^^s": 1.0, "^st": 1.0}), {}
    once = toxicity.restored_words(text, model, kept)
    assert sorted(parts) == ["$tones", "r.i.v.e.r"]
    assert toxicity.restored_words(text * 20, model, kept) == once and len(parts) == 2
    monkeypatch.setattr(toxicity, "KEPT", 1)
    assert toxicity.restored_words(text * 3, model, {}) == once
    for wanted in ({"=stone", "ston", "stones", "river side", "the river"}, {"the r", "=side"}, {"by the"}, set()):
        assert toxicity.finder(wanted)(text) == toxicity.features(toxicity.WORD.findall(text)) & wanted



def test_stretches_hold_each_place():
    """Words are those of the expression, and a text restored by stretches, also remembered ones, has the words of one restored as a whole."""
    words = "idiot stupid moron loser and the of a".split()
    model = toxicity.CharacterModel({g: 9.0 for w in words for p in [f"^^{w}$"] for g in (p[k : k + 3] for k in range(len(p) - 2))})
    r, kept = random.Random(5), {}
    kinds = ("abcaab aé", "ab1_.-*~ !@$0é", "aa..  __11!!", "a b.c-d_1", "ab \n\t,.;ñß9_²٣𝒜", "a b c d.e ,f\x00\x85 ", "İiß½Ⅷ€¡“”—a b", " a. b$", "aaa b.c. $a.")
    for _ in range(5000):
        text = "".join(r.choices(r.choice(kinds), k=r.choice((3, 8, 20, 60)))).lower()
        assert toxicity.words_of(text) == toxicity.WORD.findall(text), text
        found = toxicity.restored(text, model, kept)
        if not toxicity.odd(text):
            assert found.words() == toxicity.words_of(text) and found.found == set(found.words())
            continue
        first, every, pairs = toxicity.read(text, model)
        written = toxicity.WORD.findall(text)
        near = {" ".join(p) for of in (first, written) for p in zip(of, of[1:])} | pairs
        assert found.words() == first and found.found == every and found.near(every) == near, text
