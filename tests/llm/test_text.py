from colloquy.llm.broken_pairs import broken_pairs
from colloquy.llm.speaker_turns import clean_text, label_keys, label_speakers, read_message, speaker_turns

Q = "Could you help us understand what drove revenue in the cloud business, and how much of it was mix?"
FULL = "Revenue grew because of mix. Demand in the home market remained healthy. "
CASES = [
    ("empty", Q, None, "empty_answer"), ("blank", Q, " \n", "empty_answer"), ("dash", Q, "--", "empty_answer"), ("note", Q, "[inaudible]", "empty_answer"),
    ("yes", Q, "Yes.", None), ("full", Q, FULL, None), ("cut", Q, FULL + "We remain committed to our", "truncated_answer"),
    ("cut2", Q, FULL + "Demand in the home market remained,", "truncated_answer"), ("short", Q, FULL + "We remain com...", None), ("noperiod", Q, FULL + "Demand in the home market remained healthy", None),
    ("copy", Q, Q.lower().rstrip("?"), "copied_question"), ("copy2", Q, "Question: " + Q.replace("what", "really"), "copied_question"),
    ("asks", Q, Q + " Well, sure. " + FULL, None), ("refuse", Q, "I'm afraid we can't comment on that. Next question, please.", "refusal"),
    ("partly", Q, "We don't break that out, but I can tell you this much. " + FULL, None),
    ("lang", Q, "Wir gehen davon aus, dass sich die Lage bis 2025 deutlich verbessert.", "other_language"),
    ("same", "Rechnen Sie damit, dass die Nachfrage bis 2025 wieder das alte Niveau erreicht?", "Wir gehen davon aus, dass sich die Lage verbessert.", None),
    ("word", Q, FULL + "As they say in our Lyon office, voilà.", None), ("noq", None, FULL, None), ("refuse_fr", "Quelle part de la hausse restera l’an prochain ?", "Je préfère ne pas répondre à cette question.", "refusal"),
]


def test_pairs(spark):
    filler = [(f"f{i}", Q, FULL * 3, None) for i in range(10)]
    df = spark.createDataFrame([(a, b, c, "z") for a, b, c, _ in CASES + filler] + [(CASES[0][0], Q, None, "z")], "row_id string, q string, a string, defect string")
    run = lambda d: broken_pairs(d, pair_id="row_id", prompt="q", response="a")
    got = sorted(tuple(r) for r in run(df).collect())
    assert got == sorted((a, d) for a, _, _, d in CASES if d)
    assert run(df.limit(0)).collect() == []


def test_very_long_response(spark):
    df = spark.createDataFrame([("x", Q, FULL * 20000)], "row_id string, q string, a string")
    assert broken_pairs(df, pair_id="row_id", prompt="q", response="a").collect() == []


def test_reading():
    assert clean_text("[00:00:01] Um, we you know, grew (applause) by 5% ♪ *coughs*") == "we grew by 5%"
    assert clean_text("Er... uh. [silence] 00:01:02") == ""
    assert [u[0][:2] for u in read_message("hello\n>> Ann Bell (CFO): yes\nmore\nBell, Ann: no")] == [[], ["ann bell", "~an bel"], ["ann bell", "bell"]]
    assert label_keys("A. Bell - Analyst")[:1] == ["a bell"]


PEOPLE = [
    ("p1", "c", "Operator", "operator", "Conference Operator", None), ("p2", "c", "Ann Bell", "management", "Chief Executive Officer", "X"),
    ("p3", "c", "Bo Carr", "analyst", "Analyst", "Y"), ("p4", "c", "Di Egan", "analyst", "Analyst", "Y"),
]
PEOPLE_SCHEMA = "participant_id string, case_id string, full_name string, person_role string, title string, organization string"
SEGMENTS = "segment_id long, case_id string, message_index int, role string, text string, speaker_id string, c string"


def turns(spark, rows):
    s = spark.createDataFrame([(i, *r, "z") for i, r in enumerate(rows)], SEGMENTS)
    out = speaker_turns(s, spark.createDataFrame(PEOPLE, PEOPLE_SCHEMA)).collect()
    return [(r.turn_no, r.speaker_id, r.message_index, r.text) for r in sorted(out, key=lambda r: (r.case_id, r.turn_no))]


def test_turns(spark):
    rows = [
        ("C ", 0, "moderator", "Welcome.", None), ("c", 1, "analyst", "...", "p3"), ("c", 1, "analyst", "late copy", "p4"),
        ("c", 2, "management", "We grew.", None), ("c", 3, "unknown", "[music] More um, words.", None), ("c", 4, "analyst", "Thanks.", "P3"),
        ("c", 5, None, "B. Carr: And?\nAnn Bell (CEO): It rose.", None), ("c", 6, "analyst", "CEO:\nHere: it is.", "p4"), ("c", 7, "analyst", "Odd role names two.", None),
        ("c", None, "analyst", "no index", None), (None, 1, "analyst", "no call", None), ("c", 8, None, None, "p4"), ("c", 9, None, "DI EGAAN: ok", None),
    ]
    assert turns(spark, rows) == [
        (1, "p1", 0, "Welcome."), (2, "p2", 2, "We grew. More words."), (3, "p3", 4, "Thanks. And?"),
        (4, "p2", 5, "It rose. Here: it is. Odd role names two."), (5, "p4", 9, "ok"),
    ]
    assert turns(spark, []) == []


def test_turns_over_blocks(spark, monkeypatch):
    import colloquy.llm.speaker_turns as st

    rows = [("c", i, None, f"Word {i}.", "p2" if i % 7 == 0 else "p3" if i % 7 == 3 else None) for i in range(60)]
    whole = turns(spark, rows)
    monkeypatch.setattr(st, "BLOCK", 4)
    assert turns(spark, rows) == whole and len(whole) == 18


def test_first_messages_without_a_name(spark):
    rows = [("c", 0, None, "please open the line next question line", None), ("c", 1, None, "Operator: next question please the line is open", None), ("c", 2, None, "revenue grew strongly", "p2")]
    assert turns(spark, rows)[0][:3] == (1, "p1", 0)


def test_label_speakers(spark):
    df = spark.createDataFrame([(1, "C", "BELL, ANN"), (2, "c", "D. Egan"), (3, "c", None), (4, "c", "Nobody"), (5, "c", "carr (Analyst)")], "id long, case_id string, speaker string")
    got = label_speakers(df, spark.createDataFrame(PEOPLE, PEOPLE_SCHEMA), case="case_id", label="speaker", row_id="id")
    assert {r.id: r.speaker_id for r in got.collect()} == {1: "p2", 2: "p4", 3: None, 4: None, 5: "p3"}
