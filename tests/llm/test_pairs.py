"""Problem 6 on hand-made pairs."""

from pyspark.sql import functions as F

from strandline.llm import pairs
from strandline.llm.pairs import defective_pairs
from strandline.session import stage

QUESTIONS = [f"{a} {b}?" for a in ("What does the last speaker want to do", "How could the listener respond to this", "Why does the speaker say this") for b in ("in this clip", "in the video", "now")]
SCHEMA = "pair_table string, pair_id bigint, question string, text string"
GOOD = "The speaker wants to close the meeting because the room has gone quiet. The others will probably react by leaving the room"


REFUSALS = ("My guidelines do not allow me to comment on private persons.", "I cannot answer this question, please ask me something else.", "I'm sorry, but I can't describe the people in this video.", "Unfortunately, I am not able to help you with that request.")


def run(spark, languages, cases):
    rows = [("t", i, q, t) for i, (q, t) in enumerate(cases)]
    # refusals that recur over prompts, from which the words of refusals are learned
    rows += [("r", 100 * i + k, q, t) for i, q in enumerate(QUESTIONS) for k, t in enumerate(REFUSALS)]
    # what normal answers look like, so that sentence ends are known
    rows += [("t", 1_000 + i, QUESTIONS[i % 9], f"In scene {i} it seems calm. {GOOD}. It seems that plan {i} is to share a small joke with the group. They want to keep the floor.") for i in range(40)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, SCHEMA)
    found = defective_pairs(df, None, languages).collect()
    assert {r["defect"] for r in found if r["pair_table"] == "r"} == {"refusal"} and sum(r["pair_table"] == "r" for r in found) == len(QUESTIONS) * len(REFUSALS)
    got = {r["pair_id"]: r["defect"] for r in found if r["pair_table"] == "t"}
    assert all(k < 1_000 for k in got), got
    return [got.get(i) for i in range(len(cases))]


def test_every_defect(spark, languages):
    q = QUESTIONS[0]
    cases = [
        (q, None, "empty"), (q, " \n", "empty"), (q, "​", "empty"), (q, "[]", "empty"), (q, "N/A", "empty"), (q, "...", "empty"), (q, "<no response>", "empty"),
        (q, "[ERROR]", "error"), (q, "[ERROR] no frames", "error"), (q, "RuntimeError: CUDA error: out of memory at step 3", "error"), (q, "HTTP 503 backend overloaded", "error"),
        (q, "Traceback (most recent call last): x", "error"), (q, "The speaker talks about an error in the plan and wants it closed because the room has gone quiet.", None),
        (q, q, "copy"), (q, f"Question: {q}\nAnswer:", "copy"), (q, f"{q} {q}", "copy"), (q, q.lower().replace("last ", "").rstrip("?"), "copy"), (q, f'The question was: "{q}" {GOOD}.', None),
        (q, "I'm sorry, but I can't describe people in this video.", "refusal"), (QUESTIONS[1], "I’m sorry, but I can’t describe people in this video.", "refusal"),
        (q, "MY GUIDELINES DO NOT ALLOW ME TO ANSWER THIS QUESTION.", "refusal"), (q, 'The guest refuses and says: "I\'m sorry, I can\'t help you with that." The others want to keep the floor.', None),
        (q, "He says he cannot answer, so the listener should keep the floor.", None),
        (q, "Die Sprecherin möchte wissen, was die anderen über diesen Plan denken.", "other_language"),
        ("Was möchte die Sprecherin von den anderen über diesen Plan wissen?", "Die Sprecherin möchte wissen, was die anderen denken und ob sie morgen mit ihr kommen werden.", None),
        (q, GOOD, None), (q, f"{GOOD} because the", "truncated"), (q, f"{GOOD}. It seems that pla", "truncated"), (q, f"{GOOD}. They want to sha-", "truncated"), (q, f"{GOOD}, and the <max_tokens>", "truncated"),
    ]
    got = run(spark, languages, [(a, b) for a, b, _ in cases])
    assert got == [c for _, _, c in cases], [(x, c) for x, c in zip(got, cases) if x != c[2]]


def test_null_question_long_text_and_empty_table(spark, languages):
    long = "The speaker wants to close the meeting because the room has gone quiet. " * 2_000
    assert run(spark, languages, [(None, long), (None, None), ("", long)]) == [None, "empty", None]
    assert defective_pairs(spark.createDataFrame([], SCHEMA), None, languages).count() == 0


def test_extra_columns(spark, languages):
    df = spark.createDataFrame([("t", 1, "q", None, 5, "x")], f"{SCHEMA}, early int, opening string")
    assert [tuple(r) for r in defective_pairs(df, None, languages).collect()] == [("t", 1, "empty")]


def test_clusters_and_learned_words_find_what_no_seed_word_tells(spark, languages):
    known = "The guidelines of this service do not allow me to comment on what private persons intend."
    cases = [(q, known) for q in QUESTIONS[:4]] + [
        (QUESTIONS[5], known.replace(" me ", " us ")),  # in the cluster, without a word of the first person
        (QUESTIONS[6], "Unfortunately my guidelines allow little; please ask me something else."),  # no denial: by its words
        (QUESTIONS[0], "The guidelines of the group allow them to comment on what private persons intend."),
        (QUESTIONS[1], f"{GOOD}. {GOOD}. Unfortunately I cannot answer this question, please ask me something else."),  # after a long introduction
        (QUESTIONS[2], f'{GOOD}. She says: "I cannot answer this question, please ask me something else."'),
    ]
    assert run(spark, languages, cases) == ["refusal"] * 6 + [None, "refusal", None]


def test_language_of_a_short_question_is_that_of_its_answers(spark, languages):
    asked = "Por qué?"  # too few letters to be named
    spanish = "La persona quiere saber qué piensan los demás sobre este plan y si mañana van a ir con ella."
    cases = [(asked, spanish.replace("plan", w)) for w in ("plan", "grupo", "día", "libro")] + [(asked, f"{GOOD}.")]
    assert run(spark, languages, cases) == [None] * 4 + ["other_language"]


def test_costly_parts_are_made_once(spark, languages, monkeypatch):
    staged = []

    def keep(df, name, partitions=None):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        staged.append((name, plan, written := stage(df, name, partitions)))
        return written

    monkeypatch.setattr(pairs, "stage", keep)
    run(spark, languages, [(QUESTIONS[0], GOOD), (QUESTIONS[1], f"{GOOD}.")])
    # minima of hashes: once for prompts and once for openings, not for buckets and heads each
    assert [(name, plan.count("array_min")) for name, plan, _ in staged if "array_min" in plan] == [("bands", pairs.HASHES)] * 2
    # the pattern of tokens reads distinct parts only, below it the parts are counted
    (ends,) = (plan for name, plan, _ in staged if name == "ends")
    assert "regexp_extract_all(part" in ends and "regexp_extract_all(text" not in ends
    # an answer with a closing stop has no use for its last word
    read = {r["pair_id"]: r["last_word"] for r in next(df for name, _, df in staged if name == "pairs").where("pair_table = 't'").collect()}
    assert read[0] == "room" and read[1] is None


def test_ends_of_odd_texts(spark):
    cases = [
        ("what is naïve über", "über", False, False), ("x" * 200, "x" * 80, False, False), ("don't -- ", "don't", False, False), ("well done.", "done", False, True), ("la é", "la", False, False),
        ("wait...", "wait", False, False), ("so it ends :-)", "ends", False, True), ("a pla-", "pla", True, False), ("and the <max_tokens>", "tokens", True, False), ("", "", False, False), (None, None, None, None),
    ]
    tail = F.col("tail")
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, tail string").orderBy("i")
    assert [tuple(r) for r in df.select("tail", pairs._last_word(tail), pairs._is_cut(tail), pairs._is_stopped(tail)).collect()] == cases
