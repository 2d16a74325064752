"""Problem 7 on hand-made transcripts."""

import pytest

from strandline.llm import turns

NOTES = ("laughter", "sighs", "door slams", "background music", "noise", "breath")
TALK = ("we saw the lamp near the door", "let me water the plants first", "there is noise from the street", "the recording starts after the beep", "room 12 is already taken", "it's half past ten already")


@pytest.fixture(scope="module")
def tagger():
    texts = []
    for i in range(432):
        note, talk = NOTES[i % len(NOTES)], TALK[i % len(TALK)]
        a, b = ("[", "]"), ("{", "}")
        o, c = (a, b, ("(", ")"), ("<", ">"), ("*", "*"), ("((", "))"))[i // 6 % 6]
        more, label = TALK[(i * 5 + 1) % len(TALK)], f"P{i % 2 + 1}:"
        texts.append((f"{label} {talk} {o}{note}{c} um. {more}", f"{label} {o}{note}{c} {talk} uh {more}", f"{label} um {talk} {o}{note}{c} {more}")[i // 36 % 3])
        if i % 8 == 0:  # bracketed speech
            words = talk.split()
            texts.append(" ".join([*words[:1], f"({' '.join(words[1:3])})", *words[3:]]))
    return turns.Tagger.fit(texts)


CASES = [
    ("00:00:07.515 --> 00:00:09.515 We saw the lamp!", "we saw the lamp"),
    ("{00:50} It's half - past ten", "it's half past ten"),
    ("<56.1s> Speaker 2: let me, um, water the plants", "let me water the plants"),
    (">> A: [door slams] WE SAW THE LAMP", "we saw the lamp"),
    ("[P2] (noise) room 12 is; already taken uhm...", "room 12 is already taken"),
    ("there (is noise) from the street", "there is noise from the street"),
    ("the (recording starts) after the beep", "the recording starts after the beep"),
    ("SPEAKER_1 - it’s half past ten hmm", "it's half past ten"),
    ("that's 00:01:32,055 what we saw", "that's what we saw"),
    ("((laughter)) ummm. *sighs*", ""),
    ("", ""),
    (None, ""),
]


def test_cleaning(tagger):
    assert tagger.clean([t for t, _ in CASES]) == [w for _, w in CASES]


def test_speaker_is_the_first_token_tagged_as_one(tagger):
    said = tagger.read(["<56.1s> Speaker 2: let me", ">> A: [door slams] we saw", "[P3] (noise) room 12", "SPEAKER_1 - it’s late", "we saw speaker 2: the lamp", "so plan b: water", "00:01 [laughter]", None])
    assert [s for _, s in said] == ["p2", "p1", "p3", "p1", None, None, None, None]


def test_long_text(tagger):
    assert len(tagger.clean(["we saw the lamp near the door " * 3_000])[0].split()) == 21_000


SCHEMA = "utterance_id bigint, interaction_id string, speaker_role string, speaker_file_id string, global_index int, start_s double, transcript string, chunk int, at string"


def run(spark, tagger, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in turns.speaker_turns(df, tagger).collect())


def test_turns(spark, tagger):
    rows = [
        (1, "i", "Speaker 1", None, 9, 1.0, "we saw"),
        (2, "i", None, "x_B", 1, 900.0, "the lamp"),
        (3, "i", "P-1", None, 2, 301.0, "near the door"),
        (4, "i", "B", None, 3, 302.0, "(sighs) um"),
        (5, "i", "?", "x", 3, 303.0, "p1 : first"),
        (6, "i", "?", "x", 3, 304.0, "let me"),
        (7, None, "B", None, 3, 304.0, "let me"),
        (8, "j", "B", None, 70, None, "the street"),
        (9, "j", "A", None, 3, 500.0, "from"),
        (10, "j", "spk_02", None, 69, 1.0, "noise"),
        (11, "j", "participant 1", None, 1, 9.0, None),
    ]
    assert run(spark, tagger, rows + rows[:4]) == [
        ("i", 1, "p1", "we saw near the door first"),
        ("i", 2, "p2", "the lamp"),
        ("j", 1, "p1", "from"),
        ("j", 2, "p2", "noise the street"),
    ]


def test_turn_numbers_over_many_chunks(spark, tagger):
    import random

    coin = random.Random(2)
    rows = [(i, "k", coin.choice("AB"), None, i, 97.0 * i, f"word{i}") for i in range(200)]
    expected, last = [], None
    for _, _, s, _, _, _, text in rows:
        if s == last:
            expected[-1][1] += f" {text}"
        else:
            expected.append([{"A": "p1", "B": "p2"}[s], text])
        last = s
    coin.shuffle(rows)
    assert [(s, t) for _, _, s, t in run(spark, tagger, rows)] == [tuple(e) for e in expected]


def test_empty(spark, tagger):
    assert run(spark, tagger, []) == []
    assert run(spark, None, [(1, "i", "A", None, 1, 1.0, None)]) == []
