import random

from millrace.llm.sentences import BoundaryModel, sentence_spans

PLACES, PEOPLE = ["Atyrau", "Aktau", "Kamyskol"], ["Dr. A. Kim", "R. Melk Jr.", "Prof. L. Tuz"]


def sentence(r):
    start = r.choice(["Near", "After", "Between", "Sensors", "Operators", "In"])
    tail = r.choice([f"under {r.choice(PEOPLE)} fell", f"at p. {r.randrange(90)} noted a rise of {r.randrange(90)}.{r.randrange(9)} cm", "saw approx. 7 units etc"])
    return f"{start} {r.choice(PLACES)} the team {tail}" + r.choice([".", ".", ".", "!", "?"])


def corpus(n, seed):
    """Texts with their true spans."""
    r = random.Random(seed)
    for _ in range(n):
        text, spans = "", []
        for p in range(r.randrange(1, 5)):
            text += "\n\n" if p else ""
            for k in range(r.randrange(1, 5)):
                text += " " if k else ""
                s = sentence(r)
                spans.append((len(text), len(text) + len(s)))
                text += s
        yield text, spans


def fitted():
    return BoundaryModel().fit([t for t, _ in corpus(1500, 1)])


def test_held_out_accuracy():
    model = fitted()
    right = got = want = 0
    for text, spans in corpus(300, 2):
        found = model.split(text)
        right += len(set(found) & set(spans))
        got += len(found)
        want += len(spans)
    assert right / got > 0.97
    assert right / want > 0.97


def pieces(model, text):
    return [text[a:b] for a, b in model.split(text)]


def test_rules_of_layout_and_quotes():
    m = fitted()
    assert pieces(m, "Bulletin 4\n\nNear Atyrau the team fell.\r\n\r\n- After Aktau. It rose\n- In Aktau") == ["Bulletin 4", "Near Atyrau the team fell.", "- After Aktau. It rose", "- In Aktau"]
    assert pieces(m, "«Стоп! Вода растёт. Ждите», — сказал он.") == ["«Стоп! Вода растёт. Ждите», — сказал он."]
    assert pieces(m, "水位上升。第二站３．５米？“停。快走。”他说。Pm2站好") == ["水位上升。", "第二站３．５米？", "“停。快走。”他说。", "Pm2站好"]
    assert pieces(m, "जल बढ़ा। ठीक है।") == ["जल बढ़ा।", "ठीक है।"]
    assert pieces(m, "  \n\t ") == []
    assert pieces(m, "no end mark at\nall") == ["no end mark at\nall"]
    assert pieces(m, "1) First one.\n2) Second (cf. Fig.\n31) that one.\n3) Third") == ["1) First one.", "2) Second (cf. Fig.\n31) that one.", "3) Third"]


def test_outside_sentences_is_blank():
    m = fitted()
    for text, _ in corpus(50, 3):
        text = "  " + text.replace(" ", " ", 2) + " \n"
        inside = [False] * len(text)
        last = 0
        for a, b in m.split(text):
            assert last <= a < b
            assert not text[a].isspace()
            assert not text[b - 1].isspace()
            inside[a:b] = [True] * (b - a)
            last = b
        assert all(i or c.isspace() for i, c in zip(inside, text, strict=True))


def test_untrained_model_trusts_shape():
    m = BoundaryModel().fit([])
    assert pieces(m, "One two. Three 2.5 four. five") == ["One two.", "Three 2.5 four. five"]


def test_frame(spark):
    rows = [(1, "Near Aktau. It rose."), (1, "Near Aktau. It rose."), (2, None), (3, ""), (4, " \n "), (None, "Alone."), (5, "word. " * 200_000), (6, "x" * 1_000_000), (7, "😀 ok. No.")]
    rows[-1] = (7, "😀 ok. No.")
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sent_start", "'x' AS sent_end")
    got = sorted(tuple(r) for r in sentence_spans(df).collect() if r["doc_id"] in (1, 2, 3, 4, 7))
    assert got == [(1, 0, 11), (1, 0, 11), (1, 12, 20), (1, 12, 20), (7, 0, 5), (7, 6, 9)]
    assert sentence_spans(df.limit(0)).count() == 0
    assert sentence_spans(df.filter("doc_id IS NULL")).first()["doc_id"] is None


def test_odd_long_texts_take_no_long_time():
    import time

    m = fitted()
    began = time.time()
    for text in (" " * 500_000, "." * 300_000, "水位上升。" * 50_000, "«" * 100_000, "\n" * 300_000 + "a", '"' * 99_999, "x" * 500_000):
        m.split(text)
    assert time.time() - began < 20


def test_long_quotations_are_one_sentence():
    from millrace.llm.sentences import candidates

    inside = "The level rose. It fell again. " * 100
    for opening, closing in ("„“", "“”", "«»", "「」", '""'):
        text = f"Crews said {opening}{inside}{closing} at noon. Then it rained."
        assert next(candidates(text, 0, len(text)))[0] == text.index(" Then")
        stray = f"Crews {opening} said so. Then it rained."
        assert next(candidates(stray, 0, len(stray)))[0] == stray.index(" Then")
